"""quillspark: question-answering corpus, retrieval and conversation-safety analytics on PySpark."""

__version__ = "0.1.0"
