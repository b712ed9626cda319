"""Roles that columns play, so that operators run on any table with those roles."""

from __future__ import annotations

from dataclasses import dataclass

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US

# Window and horizon lengths in hours.
WINDOWS_H = (6, 12, 24, 48)
HORIZONS_H = (6, 12, 24, 48)

# Sensors and their units, in dimension order.
SENSOR_UNITS = {
    "temperature_c": "°C",
    "pressure_bar": "bar",
    "voltage_mean_v": "V",
    "rotation_mean_rpm": "rpm",
}

# Incident signal flags, in report order.
INCIDENT_SIGNALS = (
    "type_surchauffe",
    "type_baisse_pression",
    "type_vibration",
    "type_bruit_mecanique",
    "type_surconsommation",
    "type_blocage_mecanique",
    "type_alarme_capteur",
    "type_arret_urgence",
    "type_defaut_qualite",
)

# Weights of the confidence index.
CONFIDENCE_WEIGHTS = {
    "coherence": 0.4,
    "comment_present": 0.2,
    "machine_valide": 0.2,
    "severity_valide": 0.2,
}

# Shift names in display order, and criticality levels in display order.
SHIFT_ORDER = ("matin", "apres-midi", "nuit")
CRITICALITY_ORDER = ("LOW", "MEDIUM", "HIGH")

# Substrings that mark a column as personal data, and direct identifiers.
PII_PATTERNS = ("operator", "name", "nom", "badge", "email", "mail", "user", "agent")
OPERATOR_PII_COLUMNS = ("operator_name", "operator_badge")

# Sensor checks.
IQR_FACTOR = 1.5
UNIT_AMPLITUDE_MAX = 1.5
SATURATION_MIN_HITS = 3
SATURATION_RATIO = 2.0
CAPACITY_RATIO_TOLERANCE = 1.0
SMD_NOTABLE = 0.1

# Chronological split points as shares of the time span.
SPLIT_RATIOS = (0.70, 0.85)
SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class Roles:
    """Which columns of a reading table are the entity, event time, sensors and production."""

    entity: str = "machine_id"
    us: str = "us"
    sensors: tuple[str, ...] = tuple(SENSOR_UNITS)
    production: str = "pieces_produced"
    windows_h: tuple[int, ...] = WINDOWS_H
    horizons_h: tuple[int, ...] = HORIZONS_H
    segment: str = "segment"
    during: str = "during_maintenance"
