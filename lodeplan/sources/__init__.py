"""Where rows live: versioned Parquet tables of our own, and Parquet that others wrote."""
