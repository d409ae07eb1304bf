"""Functions that operators share."""
