"""Training-data operators (WARC audit, language model, language ID, quality,
deduplication, decontamination, token counts, packing, materialisation, URLs).

Nothing else in the library imports this subpackage."""
