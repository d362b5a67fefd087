def in_order(df):
    """Rows by id, null first."""
    return sorted(df.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
