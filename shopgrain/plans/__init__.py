"""End-to-end flows that only compose the operators."""
