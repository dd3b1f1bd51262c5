"""From query text to DataFrames: lexer, parser, algebra, compiler."""
