"""Prompt and text optimization at corpus scale, as DataFrame plans."""
