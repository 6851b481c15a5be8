"""Part of Tidewell: operators."""
