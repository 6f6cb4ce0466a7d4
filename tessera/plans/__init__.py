"""Physical-plan helpers and the derived substrates."""
