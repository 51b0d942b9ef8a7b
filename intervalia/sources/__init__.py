"""Part of intervalia."""
