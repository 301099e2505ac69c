from corpusmill.functions import hashing, text, vectors

__all__ = ["hashing", "text", "vectors"]
