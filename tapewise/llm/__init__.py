"""Operations of a training-data pipeline: mixing, deduplication, filtering, extraction, packing and token files.

Every operator is a function over DataFrames; `queries` registers one query per operator."""
