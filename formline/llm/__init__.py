"""Training-data operators: scoring, deduplication, redaction, mixing and encoding of documents.

Every operator takes a DataFrame with an id and a text column, reads only the columns it is
told to, and returns a DataFrame.  Common conventions, tested in ``tests/llm``:

* a null text counts as empty, a null id is kept and sorts before all others;
* extra columns of the input, whatever their names, never reach the operators' internals;
* repeated rows and equal texts are legal; what they give is said in each docstring;
* an empty table gives an empty result with the same schema.
"""
