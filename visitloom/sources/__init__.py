"""Inputs, outputs and table maintenance."""
