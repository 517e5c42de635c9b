"""Training-data operators: licence scan, substring / line / near dedup, decontamination, BPE,
toxicity, language id and chat formatting. Nothing else in the library imports this package."""
