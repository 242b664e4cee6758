"""Ready-made grammars."""
