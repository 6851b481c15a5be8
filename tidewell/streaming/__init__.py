"""Part of Tidewell: streaming."""
