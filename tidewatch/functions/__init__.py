"""Part of the stress analytics library."""
