import sys

from termloom.cli import main

sys.exit(main())
