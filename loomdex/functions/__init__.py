"""Column functions and the few Arrow-batched ones that built-ins cannot express."""
