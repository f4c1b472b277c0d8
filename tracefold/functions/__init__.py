"""Part of tracefold."""
