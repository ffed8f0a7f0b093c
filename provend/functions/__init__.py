"""Scalar column expressions used by the operators (JVM-side built-ins only)."""
