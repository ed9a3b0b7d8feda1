"""Multi-step jobs composed of operators."""
