"""Review states over streams of reviews."""
