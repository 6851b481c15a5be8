"""Part of Tidewell: sources."""
