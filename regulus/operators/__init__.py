"""Table operators, each a DataFrame in and a DataFrame out."""
