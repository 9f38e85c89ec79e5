"""Operations on training corpora: scores, near copies, personal data, packing. Nothing else in the library imports this."""
