"""Readers and writers of manuals, OCR output, records, truth tables and scoreboards."""
