"""Operations of a training-data pipeline; nothing else in textloom imports this subpackage."""
