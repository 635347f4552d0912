"""Relational steps, semantic steps, their judges and calibration."""
