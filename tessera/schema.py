"""The assertion table: its columns in order, their types, vocabularies and units."""

from __future__ import annotations

from pyspark.sql import types as T

# The output columns in order, which outputs must have to be interchangeable.
ENTITY = ["entity", "entity_type", "linked_entity"]
TEMPORAL = [
    "time_lower_raw", "time_lower_source_field", "time_lower_unix_utc_us",
    "time_upper_raw", "time_upper_source_field", "time_upper_unix_utc_us",
    "utc_offset_hours", "time_accuracy_us", "temporal_source",
]
SPATIAL = [
    "latitude_wgs84", "latitude_source_field", "longitude_wgs84", "longitude_source_field", "altitude_m",
    "position_type", "raw_position", "position_source", "horizontal_accuracy_m", "vertical_accuracy_m",
    "horizontal_speed_kmh", "vertical_speed_kmh", "horizontal_speed_accuracy_kmh", "vertical_speed_accuracy_kmh",
    "heading_deg", "heading_accuracy_deg", "beam_azimuth_deg", "beam_width_deg",
]
BINDINGS = ["entity_position_link", "entity_time_link", "spatial_temporal_link"]
PROVENANCE = [
    "raw_source_path", "input_file_path", "input_record_id", "source_record_uid", "row_uid",
    "preset_id", "preset_name", "source_label", "source_tier", "deleted",
]
DERIVED = ["record_type", "record_rank"]
OUTPUT_COLUMNS = [*ENTITY, *TEMPORAL, *SPATIAL, *BINDINGS, *PROVENANCE, *DERIVED]

DOUBLE_COLUMNS = {
    "utc_offset_hours", "latitude_wgs84", "longitude_wgs84", "altitude_m", "horizontal_accuracy_m", "vertical_accuracy_m",
    "horizontal_speed_kmh", "vertical_speed_kmh", "horizontal_speed_accuracy_kmh", "vertical_speed_accuracy_kmh",
    "heading_deg", "heading_accuracy_deg", "beam_azimuth_deg", "beam_width_deg",
}
LONG_COLUMNS = {"time_lower_unix_utc_us", "time_upper_unix_utc_us", "time_accuracy_us"}


def column_type(name: str) -> T.DataType:
    if name in DOUBLE_COLUMNS:
        return T.DoubleType()
    if name in LONG_COLUMNS:
        return T.LongType()
    return T.IntegerType() if name == "record_rank" else T.StringType()


SCHEMA = T.StructType([T.StructField(c, column_type(c)) for c in OUTPUT_COLUMNS])

#: utc_offset_hours is null both where no offset applies and where a zone had to be
#: assumed; this column next to it tells which (known, unknown, or null).
OFFSET_STATE = "utc_offset_state"

# Controlled vocabularies.
ENTITY_POSITION = ["at", "within_range_of", "at_fixed_detector", "references", "claimed_at", "inferred", "unknown"]
SPATIAL_TEMPORAL = [
    "instant", "continuous_during_interval", "once_during_interval", "sporadic_during_interval",
    "never_during_interval", "unknown_during_interval",
]
GENESIS = {
    "observed_at": "presence", "event_at": "action", "recorded_at": "system",
    "reported_for": "reported", "intended_for": "planned", "unknown": "unknown",
}
VOCABULARIES = {
    "entity_position_link": ENTITY_POSITION,
    "entity_time_link": list(GENESIS),
    "spatial_temporal_link": SPATIAL_TEMPORAL,
    "source_tier": ["primary", "secondary", "unknown"],
    "deleted": ["intact", "deleted", "recovered", "unknown"],
}

# Factors to the canonical unit.
UNITS = {
    "speed": {"m/s": 3.6, "km/h": 1.0, "mph": 1.609344, "knots": 1.852},
    "length": {"m": 1.0, "ft": 0.3048},
    "angle": {"deg": 1.0},
}


def unit_factor(column: str, unit: str) -> float:
    """Factor from `unit` to the column's own; an unknown pair is an error."""
    kind = "speed" if column.endswith("_kmh") else "length" if column.endswith("_m") else "angle" if column.endswith("_deg") else None
    if kind is None or unit not in UNITS[kind]:
        raise ValueError(f"no conversion of unit {unit!r} for {column}")
    return UNITS[kind][unit]


#: What the engine fills itself; a preset may not assign these.
ENGINE_OWNED = {
    "time_lower_raw", "time_lower_source_field", "time_lower_unix_utc_us", "time_upper_raw", "time_upper_source_field",
    "time_upper_unix_utc_us", "latitude_source_field", "longitude_source_field", "input_file_path", "source_record_uid",
    "row_uid", "preset_id", "preset_name", "record_type", "record_rank",
}
ASSIGNABLE = [c for c in OUTPUT_COLUMNS if c not in ENGINE_OWNED]

#: Columns whose presence makes a row more complete than another of its group.
COMPLETENESS = [
    "entity", "linked_entity", "time_lower_raw", "time_lower_unix_utc_us", "time_upper_raw", "time_upper_unix_utc_us",
    "utc_offset_hours", "time_accuracy_us", "temporal_source", "latitude_wgs84", "longitude_wgs84", "altitude_m",
    "raw_position", "position_source", "horizontal_accuracy_m", "vertical_accuracy_m", "horizontal_speed_kmh",
    "vertical_speed_kmh", "heading_deg", "heading_accuracy_deg", "beam_azimuth_deg", "beam_width_deg", *BINDINGS,
]

#: Columns whose content a row's id is made of.
IDENTITY_COLUMNS = [
    c for c in OUTPUT_COLUMNS
    if c not in {"raw_source_path", "input_file_path", "input_record_id", "source_record_uid", "row_uid", "preset_id",
                 "preset_name", "source_label", "source_tier", "record_type", "record_rank"}
]
