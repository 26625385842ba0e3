"""Column expressions: rule tables, span extraction, overlap resolution, masks, pseudonyms."""
