"""Declared schemas of the normalised tables; readers apply them, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TABLES = {
    "observations": "recording_id string, roi_index short, frame int, time_s double, gcamp double, red double, gcamp_valid boolean, red_valid boolean",
    "animals": "animal_id string, session_id string, recording_id string, genotype string, acquisition_date string, n_frames long, n_rois long, n_stimulations long, volume_interval_s double, quality_flags array<string>",
    "neurons": "recording_id string, roi_index short, roi_id string, label string, label_status string, label_duplicated boolean, neuron_id string, trace_source string",
    "trials": "trial_id string, animal_id string, session_id string, recording_id string, event_index_in_file long, stim_index_in_recording long, stim_frame long, next_stim_frame long, stimulus_start_s double, target_code string, target_roi_index short, target_label string, target_neuron_id string, previous_trial_id string, time_since_previous_s double, trial_qc_flags array<string>",
    "autoresponses": "trial_id string, frame int, time_rel_s double, gcamp double, red double, gcamp_valid boolean, red_valid boolean",
    "edges": "edge_row long, source_neuron_id string, target_neuron_id string, edge_kind string, synapse_count float, sign string, confidence float, source_reconstruction string, life_stage string, provenance_reference string",
    "neuron_attributes": "neuron_id string, attribute string, value string, role string, source string, source_member string, raw_value string, raw_label string, via_alias string, ambiguous_assignment boolean, note string",
    "aliases": "alias string, canonical_neuron_id string, kind string, ambiguous boolean, n_candidates int, reason string, observed_in array<string>, mapping_version string",
    "conflicts": "conflict_id string, entity_type string, entity_id string, attribute string, conflict_kind string, severity string, values array<string>, sources array<string>, raw_values array<string>, note string",
}


def schema(table: str) -> T.StructType:
    """The table's schema; needs a running session to parse it."""
    return T.StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns, cast to its types; a missing column is an error."""
    want = schema(table)
    missing = [f.name for f in want if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks {', '.join(missing)}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in want])
