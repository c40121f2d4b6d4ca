import sys

from setaudit.cli import main

sys.exit(main())
