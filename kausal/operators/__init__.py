"""Moments, skeleton search, orientation, evaluation, diagnostics."""
