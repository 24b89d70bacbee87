"""Operations of a training-data pipeline: dedup, decontamination, filtering, mixing, token files, scoring."""
