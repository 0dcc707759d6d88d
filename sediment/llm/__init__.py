"""Training-data operators: each module holds one operator, ``queries`` registers them.

Conventions shared by every operator of this subpackage

* a null text is an empty text;
* columns an operator adds replace columns of the same name in its input, scratch columns start
  with ``__`` and never leave it;
* an empty table gives an empty result with the same schema;
* repeated rows are separate rows unless the operator's docstring says otherwise.
"""
