"""What is done to documents: validation, and changes as functions from one state to the next."""
