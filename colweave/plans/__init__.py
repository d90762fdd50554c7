"""The public operations, composed of the operators."""
