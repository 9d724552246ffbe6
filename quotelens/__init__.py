"""quotelens: quote matching and price intelligence on PySpark DataFrames."""
