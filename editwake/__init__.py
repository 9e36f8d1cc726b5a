"""editwake: searching revision diffs and turning the hits into trends, on Spark.

Everything is a DataFrame transformation or a Column expression; see README.md
for the layout and for what deliberately differs from a text index.
"""
