"""lodeplan: semantically typed tables, structured plans and English questions on Spark."""
