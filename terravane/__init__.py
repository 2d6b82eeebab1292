"""terravane: software-estate analytics and training-data operators on PySpark DataFrames."""
