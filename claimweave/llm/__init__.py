"""Training-data operators: formatting, scanning, deduplication, scoring, tokenisation."""
