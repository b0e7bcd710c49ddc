"""Numeric kernels: arrays in, numbers out, no Spark."""
