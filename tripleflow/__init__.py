"""tripleflow: turning nested records into a graph of (subject, predicate, object) rows and working on it with Spark.

Operators are functions from DataFrames to DataFrames. Nothing in here starts an action unless its docstring says so.
"""
