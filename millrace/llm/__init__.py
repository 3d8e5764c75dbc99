"""Training-data operators: licence scans, WARC, FLAC, tokenisation, language ID, mixing, deduplication, chat."""
