"""Operations of a training-data pipeline over text, vectors, pages and dialogues."""
