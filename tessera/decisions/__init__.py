"""Context, trust, claims, evidence packs, decisions and calibration."""
