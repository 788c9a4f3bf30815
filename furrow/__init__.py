"""Spatio-temporal detection analytics as DataFrame operators."""
