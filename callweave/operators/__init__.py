"""Operators over utterance tables; every function takes DataFrames and returns DataFrames."""
