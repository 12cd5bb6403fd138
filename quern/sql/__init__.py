"""Oracle-dialect SQL: lexer, parser and lowering to Spark SQL."""
