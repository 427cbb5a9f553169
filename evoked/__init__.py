"""Event-aligned analysis of spike trains, stimulation trials and field potentials on Spark DataFrames."""
