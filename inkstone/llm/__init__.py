"""Operations of a training-data pipeline over `documents`, `pages`, `benchmark`, `labels` and `conversations`.

Nothing else in the library imports this subpackage.
"""
