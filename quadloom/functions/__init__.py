"""Column functions: XSD lexical rules and SPARQL built-ins."""
