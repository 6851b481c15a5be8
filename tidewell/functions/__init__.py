"""Part of Tidewell: functions."""
