"""Training-data operators: packing, dedup, decontamination, classifiers, LM scoring, URL rules, token counts."""
