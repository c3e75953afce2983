"""Operations of a training-data pipeline: deduplication, scoring, extraction, packing and output of text."""
