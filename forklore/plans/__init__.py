"""User-facing metrics, composed of the operators."""
