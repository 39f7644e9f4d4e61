"""corpusloom: captured web pages to a clean text corpus, as DataFrame operators."""

__version__ = "0.1.0"
