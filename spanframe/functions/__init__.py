"""Column functions over text: normalisation, scripts, transliteration, chunks."""
