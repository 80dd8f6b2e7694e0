"""Sampling plans for generated utterances."""
