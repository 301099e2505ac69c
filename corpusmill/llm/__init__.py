"""Training-data operators for large text corpora.

One module per operator.  Every operator is a function of DataFrames with its
column names as parameters; ``queries`` binds them to the test tables.
Nothing outside this subpackage imports it.
"""
