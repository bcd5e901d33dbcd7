"""Streams into tables.  Questions are asked of tables only; there are no windows or watermarks here."""
