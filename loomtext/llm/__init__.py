"""Training-data operators: dedup, decontamination, packing, scoring, scans."""
