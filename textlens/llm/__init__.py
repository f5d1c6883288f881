"""Training-data pipeline operators.

One module per operator; ``queries`` registers one query per operator.
Nothing outside this subpackage imports it.
"""
