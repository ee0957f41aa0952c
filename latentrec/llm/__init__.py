"""Operators for preparing language-model training data, at corpus scale.

Each module holds one operator with its general interface; ``queries`` derives
the registered ``opN_<name>`` queries from them. Nothing outside this
subpackage imports it.
"""
