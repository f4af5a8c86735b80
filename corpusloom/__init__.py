"""corpusloom: analytics over text corpora and concept graphs, as plain DataFrame operators.

Nothing here imports the subpackage ``corpusloom.llm``; it stands on top of the rest.
"""

__version__ = "0.1.0"
