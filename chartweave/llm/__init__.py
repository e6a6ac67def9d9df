"""Operations of a training-data pipeline: tokens, search, shards, deduplication, quality,
language and mixing. Nothing outside this subpackage imports it."""
