"""Context reduction for language-model requests, as Spark plans."""
