"""Training-data operators: packing, WARC, token files, media, PII, token counts, quality, near-duplicates,
decontamination and secret scans. Nothing else in the library imports this subpackage."""
