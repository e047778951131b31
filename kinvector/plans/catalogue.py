"""Registered queries of the library and their SQL."""

from __future__ import annotations

from kinvector.plans import detections, galleries, retrieval, service, streams

MODULES = (retrieval, detections, service, galleries, streams)
NAMES = """
cosine_topk euclidean_topk nearest_entity_three_tier three_tier_inverted_thresholds decision_counts similarity_stats
k_reciprocal_rerank k_reciprocal_topk spatiotemporal_rerank embedding_quality_check weighted_centroid unweighted_centroid
ema_centroid online_gallery_assign online_gallery_shared online_gallery_stats gallery_snapshot_roundtrip gallery_load_merge stream_gallery_assign stream_detection_counts
confidence_strata detector_stats overlapping_detections non_overlapping_detections valid_crops ring_buffer_latest buffer_stats
admission_candidates lru_evict ttl_expired prune_union gallery_stats camera_locf_grid throughput_windows labels_palette
jobs_page jobs_count dashboard_counts recent_jobs job_overlay job_status_fold bulk_delete config_upsert job_metrics
config_json_fields model_catalog queue_messages stream_metadata_check selection_toggle config_clone detections_from_arrays sampled_history running_best
job_insert job_by_id configs_changed_by_id config_answers configs_newest config_lookup jobs_with_news live_hash_writes video_downloads
pipeline_counters streams_progress embedder_stats admission_with_force buffer_fill
bounded_gallery_assign bounded_gallery_entities bounded_gallery_stats bounded_gallery_history worker_final_stats
embedded_in_calls live_overlay streams_finished cross_camera_pairs pruned_topk overlapping_pairs
bounded_gallery_resume bounded_gallery_stream bounded_gallery_epochs
label_forms detection_batches frame_numbers matches_by_place downloadable_jobs serial_ids service_tables
""".split()


def queries():
    return {n: getattr(m, n) for n in NAMES for m in MODULES if hasattr(m, n)}


def oracle_sql():
    return {n: getattr(m, n.upper()) for n in NAMES for m in MODULES if hasattr(m, n.upper())}
