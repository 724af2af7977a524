"""Quillstone: document retrieval, its evaluation and the tables around it, as Spark plans."""
