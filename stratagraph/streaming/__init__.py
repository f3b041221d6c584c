"""Extensions over streams; batch results are the contract."""
