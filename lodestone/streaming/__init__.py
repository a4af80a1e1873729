"""Empty on purpose: all inputs are bounded, and none of the operators has a streaming form."""
