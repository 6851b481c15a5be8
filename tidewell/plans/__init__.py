"""Part of Tidewell: plans."""
