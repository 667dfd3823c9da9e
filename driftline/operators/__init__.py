"""Relations, measures, windows, detectors, splitting and evaluation on event logs."""
