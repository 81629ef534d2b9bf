"""Part of parcelworks; see README.md."""
