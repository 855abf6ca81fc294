"""From the text of a statement to a DataFrame: lexer, parser, names, types, lowering."""
