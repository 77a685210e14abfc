"""rivulet: ordered dataflow, text and retrieval analytics as DataFrame plans."""
