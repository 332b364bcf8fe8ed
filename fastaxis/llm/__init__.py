"""Training-data operators. Nothing outside this subpackage imports it.

Every operator lives in a module of its own, with a general interface; the thin
``opN_<name>`` queries and their SQL live in ``fastaxis.llm.registry``.
"""
